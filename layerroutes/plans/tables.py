"""Queries of sources, units, alignment, streams and user functions (S, U, A, W, F)."""

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from layerroutes.functions import arrays as A
from layerroutes.functions.hashing import uniform
from layerroutes.operators import align, monitor, units
from layerroutes.plans import fixtures as fx
from layerroutes.plans.evaluation import far_sql
from layerroutes.plans.fixtures import sql, uniform_sql
from layerroutes.plans.registry import query
from layerroutes.sources import tables as S
from layerroutes.sources import user as U
from layerroutes.sources.scratch import shared_dir
from layerroutes.streaming import monitor as stream

r6 = lambda c, name=None: F.round(c, 6).alias(name or c)
NORM = r"trim(regexp_replace(text, '[ \t\r\n\f\x0b]+', ' ', 'g'))"


def norm(c="text"):
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f\x0b]+", " "))


@query("SELECT d.doc_id, lang, n_chars, quality::INT AS quality FROM documents d LEFT JOIN labels USING (doc_id)")
def s02_labelled_scan(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return S.with_labels(docs, fx.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query(sql("SELECT row_id, n_tokens, finish_reason FROM emb WHERE finish_reason <> 'length' AND level <> 3 ORDER BY row_id LIMIT 100", "emb"))
def s03_row_filters(spark, d):
    return fx.emb(spark, d).where("finish_reason <> 'length' and level <> 3").orderBy("row_id").limit(100).select("row_id", "n_tokens", "finish_reason")


@query(sql("SELECT row_id, layer, list_transform(x, lambda v: round(v, 6)) AS x FROM states WHERE layer IN (0, 6, 7)", "states"))
def s04_layers(spark, d):
    return fx.states(spark, d).where(F.col("layer").isin(S.layer_ids([0, -1, -2], fx.LAYERS))).select("row_id", "layer", A.rounded(F.col("x")).alias("x"))


@query(sql("p AS (SELECT sample, count(DISTINCT n_tokens) AS k, max(token_end) AS last, max(n_tokens) AS n, count(*) AS r, count(DISTINCT token_end) AS e FROM u GROUP BY sample) SELECT 'empty_id' AS rule, count(*) FILTER (sample IS NULL) AS n FROM u UNION ALL SELECT 'range', count(*) FILTER (token_end < 1 OR token_end > n_tokens) FROM u UNION ALL SELECT 'repeated', sum(r - e)::BIGINT FROM p UNION ALL SELECT 'n_tokens', count(*) FILTER (k > 1) FROM p UNION ALL SELECT 'not_final', count(*) FILTER (last <> n) FROM p", "evt").replace("p AS (SELECT sample", "u AS (SELECT sample, CASE WHEN event_id % 97 = 0 THEN token_end + 1 ELSE token_end END AS token_end, CASE WHEN event_id % 501 = 0 THEN n_tokens + 2 ELSE n_tokens END AS n_tokens FROM evt), p AS (SELECT sample", 1))
def s06_violations(spark, d):
    """The contract on rows with faults planted by id."""
    e = fx.evt(spark, d)
    u = e.select("sample", F.when(F.col("event_id") % 97 == 0, F.col("token_end") + 1).otherwise(F.col("token_end")).alias("token_end"), F.when(F.col("event_id") % 501 == 0, F.col("n_tokens") + 2).otherwise(F.col("n_tokens")).alias("n_tokens"))
    return S.violations(u)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT (l_suppkey, l_partkey)) AS kinds FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def s07_repeated_ids(spark, d):
    g = fx.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey", "l_partkey").alias("kinds"))
    return g.where("n > 1")


@query("WITH c AS (SELECT l_returnflag || l_linestatus AS name, count(*) AS n FROM lineitem GROUP BY ALL), w AS (SELECT name, CASE WHEN name = 'NO' THEN n + 5 ELSE n END AS expected FROM c UNION ALL SELECT 'DRONE', 10) SELECT name, expected, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n < expected THEN 'incomplete' ELSE 'available' END AS status FROM w LEFT JOIN c USING (name)")
def s08_completeness(spark, d):
    c = fx.table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("name")).agg(F.count("*").alias("n"))
    want = c.select("name", F.when(F.col("name") == "NO", F.col("n") + 5).otherwise(F.col("n")).alias("expected")).union(spark.createDataFrame([("DRONE", 10)], "name string, expected long"))
    return want.join(c, "name", "left").select("name", "expected", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "missing").when(F.col("n") < F.col("expected"), "incomplete").otherwise("available").alias("status"))


TOK = "tok AS (SELECT doc_id, w.i::INT AS pos, t[w.i] AS token FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents), LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i) w), ends AS (SELECT *, (sum(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1)::BIGINT AS char_end FROM tok)"


def tokens(spark, d):
    t = fx.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("p", "token"))
    w = Window.partitionBy("doc_id").orderBy("p")
    return t.select("doc_id", (F.col("p") + 1).alias("pos"), "token", (F.sum(F.length("token") + 1).over(w) - 1).alias("char_end"))


@query("WITH " + TOK + " SELECT doc_id, pos, char_end, length(token) AS n FROM ends")
def s09_ragged(spark, d):
    return tokens(spark, d).select("doc_id", "pos", "char_end", F.length("token").cast("long").alias("n"))


@query(sql("SELECT layer, count(*) FILTER (len(list_filter(x, lambda v: isnan(v) OR isinf(v))) > 0) AS bad, count(*) AS n FROM states GROUP BY layer", "states"))
def s10_non_finite(spark, d):
    bad = F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    return fx.states(spark, d).groupBy("layer").agg(F.count(F.when(bad, 1)).alias("bad"), F.count("*").alias("n"))


@query("WITH m AS (SELECT conv_id, max(turn) AS turns FROM conversations GROUP BY conv_id) SELECT c.conv_id, c.turn, c.role, turns FROM m LEFT JOIN conversations c ON c.conv_id = m.conv_id AND c.turn = m.turns")
def s11_sample_table(spark, d):
    c = fx.table(spark, d, "conversations")
    meta = c.groupBy("conv_id").agg(F.max("turn").alias("turns"))
    return meta.join(S.keep_last(c.select("conv_id", "turn", "role"), ["conv_id"], F.col("turn")), "conv_id", "left").select("conv_id", "turn", "role", "turns")


@query("SELECT d.doc_id, lang, coalesce(quality, 0)::INT AS label FROM documents d LEFT JOIN labels USING (doc_id)")
def s11_coalesced_labels(spark, d):
    """Labels from the first column that is there; 0 where none is known."""
    rows = fx.table(spark, d, "documents").select("doc_id", "lang").join(fx.table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", "lang", S.coalesced_label(rows, ("is_correct", "quality", "toxic")).alias("label"))


@query("WITH s AS (SELECT o_orderkey, o_totalprice::DOUBLE AS price FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND " + uniform_sql("select", "o_orderkey") + " < 0.5), h AS (SELECT * FROM s ORDER BY o_orderkey LIMIT 200) SELECT * FROM h ORDER BY o_orderkey DESC LIMIT 50")
def s12_selection(spark, d):
    s = fx.table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 100000").where(uniform("select", F.col("o_orderkey")) < 0.5)
    return s.orderBy("o_orderkey").limit(200).orderBy(F.desc("o_orderkey")).limit(50).select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"))


@query("WITH s AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 50000 AND " + uniform_sql("select", "o_orderkey") + " < 0.6), h AS (SELECT * FROM s ORDER BY o_orderkey LIMIT 300) SELECT * FROM h ORDER BY o_orderkey DESC LIMIT 80")
def s12_by_ids(spark, d):
    """Sample ids from a table, item ids from a list, then predicate, share, head and tail."""
    own = fx.table(spark, d, "customer").where("c_nationkey < 12").select("c_custkey")
    s = S.selection(fx.table(spark, d, "orders"), "o_orderkey", ["1-URGENT", "2-HIGH"], "o_orderpriority", own, "o_custkey", "o_totalprice > 50000", 0.6, "select", 300, 80)
    return s.select("o_orderkey", "o_custkey")


@query("SELECT l.l_orderkey, l_partkey, o.o_orderkey AS sample__o_orderkey, o.o_custkey AS sample__o_custkey FROM lineitem l JOIN (SELECT DISTINCT o_orderkey, o_custkey FROM orders) o ON o_orderkey = l_orderkey WHERE l_quantity > 45")
def s13_view(spark, d):
    samples = fx.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").distinct()
    items = fx.table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_partkey")
    return items.join(samples.select(F.col("o_orderkey").alias("_k"), *S.view_columns(samples)), F.col("l_orderkey") == F.col("_k")).drop("_k")


@query(sql("SELECT 'a' AS trial, layer, count(*) AS n, NULL::DOUBLE AS accuracy FROM rt WHERE layer < 4 GROUP BY layer UNION ALL SELECT 'b', layer, count(*), round(avg(label), 6) FROM rt WHERE layer >= 2 GROUP BY layer", "rt"))
def s16_collect_trials(spark, d):
    rt = fx.rt(spark, d)
    a = rt.where("layer < 4").groupBy("layer").agg(F.count("*").alias("n")).withColumn("trial", F.lit("a"))
    b = rt.where("layer >= 2").groupBy("layer").agg(F.count("*").alias("n"), r6(F.avg("label"), "accuracy")).withColumn("trial", F.lit("b"))
    return S.collect_trials([a, b]).select("trial", "layer", "n", "accuracy")


@query("WITH t AS (SELECT doc_id, text FROM documents) SELECT doc_id, (len(regexp_extract_all(text, '[.!?](\\s|$)')) + len(regexp_extract_all(text, '[。！？]')) + len(regexp_extract_all(text, '\\n+')))::BIGINT AS boundaries FROM t")
def u02_boundaries(spark, d):
    n = lambda p: F.regexp_count("text", F.lit(p))
    return fx.table(spark, d, "documents").select("doc_id", (n(r"[.!?](\s|\z)") + n("[。！？]") + n(r"\n+")).cast("long").alias("boundaries"))


_CHARS = """ch AS MATERIALIZED (SELECT doc_id, unnest(string_split(coalesce(text, ''), '')) AS c, generate_subscripts(string_split(coalesce(text, ''), ''), 1) AS i FROM documents),
 nx AS (SELECT doc_id, i, c, lead(c) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM ch),
 mk AS (SELECT doc_id, i AS place FROM nx WHERE (c IN ('.', '!', '?') AND (n IS NULL OR n IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)))) OR c IN ('。', '！', '？') OR (c = chr(10) AND (n IS NULL OR n <> chr(10)))),
 tk AS MATERIALIZED (SELECT doc_id, token, pos, (sum(length(token)) OVER (PARTITION BY doc_id ORDER BY pos) + pos - 1)::BIGINT AS char_end FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS token, generate_subscripts(string_split(coalesce(text, ''), ' '), 1)::INT AS pos FROM documents)),
 en AS MATERIALIZED (SELECT DISTINCT doc_id, token_end FROM (SELECT mk.doc_id, tk.pos AS token_end FROM mk ASOF JOIN (SELECT * FROM tk WHERE token <> '') tk ON mk.doc_id = tk.doc_id AND mk.place <= tk.char_end UNION ALL SELECT doc_id, max(pos) FROM tk GROUP BY doc_id))"""


@query("WITH " + _CHARS + " SELECT doc_id, token_end FROM en")
def u02_sentence_ends(spark, d):
    """Tokens at which a sentence ends, the last one included."""
    docs = fx.table(spark, d, "documents")
    return units.sentence_ends(docs, units.spaced_tokens(docs, "doc_id"), "doc_id")


@query("WITH " + _CHARS + ", sp AS (SELECT tk.doc_id, en.token_end, length(token) AS a, coalesce(unicode(nullif(token, '')), 0) AS b FROM tk ASOF JOIN en ON tk.doc_id = en.doc_id AND tk.pos <= en.token_end) SELECT doc_id, token_end, count(*) AS n, round(avg(a) + 1e-9, 6) AS length, round(avg(b) + 1e-9, 6) AS first_code FROM sp GROUP BY ALL")
def u04_sentence_vectors(spark, d):
    """Mean vector of each sentence; a token's vector is its length and its first code point."""
    docs = fx.table(spark, d, "documents")
    t = units.spaced_tokens(docs, "doc_id")
    v = t.select("doc_id", "pos", F.array(F.length("token"), F.ascii("token")).cast("array<double>").alias("x"))
    m = units.span_means(v, units.sentence_ends(docs, t, "doc_id"), "doc_id")
    return m.select("doc_id", "token_end", "n", F.round(F.col("x")[0] + 1e-9, 6).alias("length"), F.round(F.col("x")[1] + 1e-9, 6).alias("first_code"))


@query(sql("SELECT sample, arg_max(score, token_end) AS value, arg_max(event_id % 7, token_end)::DOUBLE AS kind FROM evt WHERE NOT is_final GROUP BY sample", "evt"))
def u01_prompt_last(spark, d):
    """The vector of each sample's last unit before the final one, which stands for its prompt."""
    v = fx.evt(spark, d).select("sample", F.col("token_end").alias("pos"), (~F.col("is_final")).alias("prompt"), F.array(F.col("score"), (F.col("event_id") % 7).cast("double")).alias("x"))
    return units.last_vectors(v, "sample", "prompt").select("sample", F.col("x")[0].alias("value"), F.col("x")[1].alias("kind"))


@query(sql("SELECT sample, token_end, round(avg(score) OVER (PARTITION BY sample ORDER BY token_end) + 1e-9, 6) AS mean FROM evt QUALIFY token_end % 10 = 0 OR is_final", "evt"))
def u03_prefix_mean(spark, d):
    w = Window.partitionBy("sample").orderBy("token_end").rowsBetween(Window.unboundedPreceding, 0)
    e = fx.evt(spark, d).withColumn("m", F.round(F.avg("score").over(w) + 1e-9, 6))
    return e.where("token_end % 10 = 0 or is_final").select("sample", "token_end", F.col("m").alias("mean"))


@query("WITH " + TOK + ", s AS (SELECT doc_id, pos, length(token) AS n, coalesce(sum((token LIKE '%.')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment FROM tok) SELECT doc_id, segment, count(*) AS tokens, round(avg(n) + 1e-9, 6) AS mean FROM s GROUP BY ALL")
def u04_sentence_mean(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = tokens(spark, d).withColumn("segment", F.coalesce(F.sum(F.col("token").endswith(".").cast("int")).over(w), F.lit(0)).cast("long"))
    return s.groupBy("doc_id", "segment").agg(F.count("*").alias("tokens"), F.round(F.avg(F.length("token")) + 1e-9, 6).alias("mean"))


@query(sql("SELECT row_id, layer, CASE WHEN layer = 7 THEN list_transform(x, lambda v: round(2 * v, 6)) ELSE list_transform(x, lambda v: round(v, 6)) END AS x FROM states", "states"))
def u07_final_swap(spark, d):
    s = fx.states(spark, d)
    alt = s.where(F.col("layer") == fx.LAYERS - 1).select("row_id", "layer", F.transform("x", lambda v: v * 2).alias("alt"))
    return s.join(alt, ["row_id", "layer"], "left").select("row_id", "layer", A.rounded(F.coalesce("alt", "x")).alias("x"))


@query(sql("p AS (SELECT DISTINCT sample, unnest([1, 16, 64, -1]) AS pos FROM evt), e AS (SELECT *, CASE WHEN is_final THEN -1 END AS last FROM evt) SELECT p.sample, pos, round(score, 6) AS score FROM p LEFT JOIN e ON e.sample = p.sample AND (e.token_end = pos OR e.last = pos)", "evt"))
def u08_positions(spark, d):
    e = fx.evt(spark, d)
    g = e.groupBy("sample").agg(*(F.max(F.when(F.col("token_end") == k, F.col("score"))).alias(str(k)) for k in (1, 16, 64)), F.max(F.when(F.col("is_final"), F.col("score"))).alias("-1"))
    return g.unpivot("sample", ["1", "16", "64", "-1"], "pos", "score").select("sample", F.col("pos").cast("int").alias("pos"), r6("score"))


@query(sql("SELECT sample, count(*) - 1 AS changes, round((arg_max(score, token_end) - arg_min(score, token_end)) / (count(*) - 1), 6) AS mean_change FROM evt GROUP BY sample HAVING count(*) >= 2", "evt"))
def u10_token_change(spark, d):
    n = F.count("*")
    g = fx.evt(spark, d).groupBy("sample").agg((n - 1).alias("changes"), ((F.max_by("score", "token_end") - F.min_by("score", "token_end")) / (n - 1)).alias("m"))
    return g.where("changes >= 1").select("sample", "changes", r6("m", "mean_change"))


@query(sql(f"SELECT sample, token_end FROM evt QUALIFY row_number() OVER (PARTITION BY sample ORDER BY {uniform_sql('pos', 'event_id')}) <= 8", "evt"))
def u11_positions_by_hash(spark, d):
    e = fx.evt(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("sample").orderBy(uniform("pos", F.col("event_id")))))
    return e.where("i <= 8").select("sample", "token_end")


@query("WITH " + TOK + ", k AS (SELECT CASE WHEN token = '' THEN 'empty' WHEN token LIKE '%' || chr(10) || '%' THEN 'newline' WHEN regexp_full_match(token, '[0-9.,]+') THEN 'number' WHEN regexp_full_match(token, '[A-Za-z]+') THEN 'text' WHEN regexp_matches(token, '[A-Za-z]') THEN 'mixed' ELSE 'symbol' END AS kind FROM tok) SELECT kind, count(*) AS n FROM k GROUP BY kind")
def u14_token_kinds(spark, d):
    t = F.col("token")
    kind = F.when(t == "", "empty").when(t.contains("\n"), "newline").when(t.rlike("^[0-9.,]+$"), "number").when(t.rlike("^[A-Za-z]+$"), "text").when(t.rlike("[A-Za-z]"), "mixed").otherwise("symbol")
    words = fx.table(spark, d, "documents").select(F.explode(F.split("text", " ", -1)).alias("token"))
    return words.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


_LENGTHS = "n AS (SELECT sample, max(n_tokens) AS n FROM evt GROUP BY sample)"


@query(sql(f"{_LENGTHS}, e AS (SELECT sample, p AS pos, row_number() OVER (PARTITION BY sample ORDER BY {uniform_sql('units', chr(39) + chr(39) + ' || sample || ' + chr(39) + '|' + chr(39) + ' || p')}, p) AS draw FROM n, range(1, 1000) t(p) WHERE n >= 65 AND p <= n) SELECT sample, draw::INT AS draw, pos::INT AS pos FROM e WHERE draw <= 65 UNION ALL SELECT sample, d::INT, (1 + floor({uniform_sql('units|again', chr(39) + chr(39) + ' || sample || ' + chr(39) + '|' + chr(39) + ' || d')} * n))::INT FROM n, range(1, 66) t(d) WHERE n < 65", "evt"))
def u11_drawn_positions(spark, d):
    """65 positions a sample, repeated ones where it is shorter."""
    n = fx.evt(spark, d).groupBy("sample").agg(F.max("n_tokens").alias("n"))
    return units.drawn_positions(n, "sample", "n", 65, "units")


@query(sql(f"{_LENGTHS}, e AS (SELECT sample, p AS pos, row_number() OVER (PARTITION BY sample ORDER BY {uniform_sql('pairs', chr(39) + chr(39) + ' || sample || ' + chr(39) + '|' + chr(39) + ' || p')}, p) AS i FROM n, range(1, 1000) t(p) WHERE p < n) SELECT sample, pos::INT AS pos FROM e WHERE i <= 5", "evt"))
def u11_adjacent_pairs(spark, d):
    """Five adjacent pairs of positions a sample."""
    n = fx.evt(spark, d).groupBy("sample").agg(F.max("n_tokens").alias("n"))
    return units.drawn_pairs(n, "sample", "n", 5, "pairs")


_PIECE = r"k AS (SELECT token AS t, regexp_replace(token, '^\\s+|\\s+$', '', 'g') AS s, pos = 1 AS special FROM tok)"


@query("WITH " + TOK + ", " + _PIECE + r""" SELECT kind, category, count(*) AS n FROM (SELECT CASE WHEN special THEN 'special' WHEN contains(t, chr(10)) THEN 'newline' WHEN NOT regexp_matches(t, '\S') THEN 'whitespace' WHEN regexp_matches(t, '\p{Nd}') THEN 'number' WHEN regexp_matches(t, '\p{L}') THEN 'text' ELSE 'symbol' END AS kind,
 CASE WHEN special THEN 'special_token' WHEN s = '' THEN 'whitespace' WHEN regexp_full_match(s, '[+−-]?\p{Nd}+([.,]\p{Nd}+)*') THEN 'number_fragment' WHEN regexp_full_match(s, '[+−*/=<>^%×÷≤≥≈±]+') THEN 'operator_fragment' WHEN contains(s, chr(92)) OR contains(s, '$') THEN 'latex_or_dollar_fragment'
 WHEN regexp_full_match(s, '\p{L}+') THEN 'alphabetic_fragment' WHEN NOT regexp_matches(s, '[\p{L}\p{N}]') THEN 'punctuation_fragment' ELSE 'mixed_or_other_fragment' END AS category FROM k) GROUP BY ALL""")
def u14_kinds_and_fragments(spark, d):
    """All kinds and categories; a text's first token stands for a special one."""
    t, special = F.col("token"), F.col("pos") == 1
    k = tokens(spark, d).select(units.token_kind(t, special).alias("kind"), units.fragment_category(t, special).alias("category"))
    return k.groupBy("kind", "category").agg(F.count("*").alias("n"))


@query(f"WITH n AS (SELECT sha256({NORM}) AS sha, doc_id, quality FROM documents JOIN labels USING (doc_id)) SELECT sha, count(*) AS n, count(DISTINCT quality) > 1 AS conflict FROM n GROUP BY sha HAVING count(*) > 1")
def u16_conflicts(spark, d):
    """Groups of equal labelled texts, and whether their labels differ."""
    docs = fx.table(spark, d, "documents").select("doc_id", F.sha2(norm(), 256).alias("sha")).join(fx.table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    g = docs.groupBy("sha").agg(F.count("*").alias("n"), (F.countDistinct("quality") > 1).alias("conflict"))
    return g.where("n > 1")


@query(sql("SELECT sample, string_agg(event_type, ',' ORDER BY token_end) AS codes FROM evt WHERE token_end > n_tokens - 16 GROUP BY sample", "evt"))
def u15_last_window(spark, d):
    e = fx.evt(spark, d).where(F.col("token_end") > F.col("n_tokens") - 16)  # at most 16 a sample
    return e.groupBy("sample").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("token_end", "event_type"))), lambda s: s["event_type"]), ",").alias("codes"))


@query(f"SELECT doc_id, sha256({NORM}) AS sha, row_number() OVER (PARTITION BY {NORM} ORDER BY doc_id) = 1 AS first FROM documents")
def u16_canonical(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.sha2(norm(), 256).alias("sha"))
    firsts = docs.groupBy("sha").agg(F.min("doc_id").alias("m"))
    return docs.join(firsts, "sha").select("doc_id", "sha", (F.col("doc_id") == F.col("m")).alias("first"))


@query(f"WITH n AS (SELECT doc_id, {NORM} AS t FROM documents), f AS (SELECT t, min(doc_id) AS doc_id FROM n GROUP BY t HAVING t NOT IN (SELECT {NORM} FROM benchmark)) SELECT doc_id FROM f ORDER BY {uniform_sql('clean', 'doc_id')} LIMIT 100")
def u17_clean_selection(spark, d):
    n = fx.table(spark, d, "documents").select("doc_id", norm().alias("t"))
    f = n.groupBy("t").agg(F.min("doc_id").alias("doc_id")).join(fx.table(spark, d, "benchmark").select(norm().alias("t")), "t", "left_anti")
    return f.orderBy(uniform("clean", F.col("doc_id"))).limit(100).select("doc_id")


SIM = "sim AS (SELECT b.layer, a.state AS a, b.state AS b, list_sum(list_transform(list_zip(a.mu, b.mu), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(a.mu, lambda v: v * v))) * sqrt(list_sum(list_transform(b.mu, lambda v: v * v)))) AS sim FROM means a JOIN means b ON b.layer = a.layer + 1)"


@query(sql(SIM + " SELECT layer, a, b, round(sim, 6) AS sim FROM sim", "means"))
def a00_similarities(spark, d):
    return align.similarities(fx.means(spark, d)).select("layer", "a", "b", r6("sim"))


@query(None)
def a01_optimal(spark, d):
    return align.optimal(align.similarities(fx.means(spark, d)), 0.2)


def _rounds(n: int) -> str:
    """Greedy matching in SQL: in each round the pairs that are best for both ends."""
    out = SIM + ", g0 AS (SELECT * FROM sim WHERE sim >= 0.2)"
    for k in range(n):
        out += f", t{k} AS (SELECT *, row_number() OVER (PARTITION BY layer, a ORDER BY sim DESC, b) AS ra, row_number() OVER (PARTITION BY layer, b ORDER BY sim DESC, a) AS rb FROM g{k}), m{k} AS (SELECT layer, a, b, sim FROM t{k} WHERE ra = 1 AND rb = 1), g{k + 1} AS (SELECT * FROM g{k} g WHERE NOT EXISTS (SELECT 1 FROM m{k} m WHERE m.layer = g.layer AND (m.a = g.a OR m.b = g.b)))"
    return out + " " + " UNION ALL ".join(f"SELECT layer, a, b, round(sim, 6) AS sim FROM m{k}" for k in range(n))


@query(sql(_rounds(6), "means"))
def a02_greedy(spark, d):
    return align.greedy(align.similarities(fx.means(spark, d)), ["layer"], 0.2).select("layer", "a", "b", r6("sim"))


def _chain(n: int) -> str:
    """Matches handed on from layer to layer in SQL: what has none is born, in layer and local order."""
    m, last = _rounds(n).split(" SELECT layer, a, b, round", 1)
    m += ", m AS (SELECT layer, a, b, round" + last + "), born AS (SELECT layer, state, row_number() OVER (ORDER BY layer, state) - 1 AS id FROM means c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.layer = c.layer AND m.b = c.state))"
    return m + ", chain AS (SELECT layer, state, id FROM born UNION ALL SELECT m.layer, m.b, id FROM chain JOIN m ON m.layer = chain.layer + 1 AND m.a = chain.state) SELECT layer, state AS local_state, id::INT AS state FROM chain"


@query(sql(_chain(6), "means").replace("WITH ", "WITH RECURSIVE ", 1))
def a03_align_layers(spark, d):
    c = fx.means(spark, d)
    return align.align_layers(c, align.greedy(align.similarities(c), ["layer"], 0.2))


@query(sql("SELECT row_id, l AS layer, level, list_transform(embedding[1 + 4 * l : 4 + 4 * l], lambda v: round(v::DOUBLE * (l + 2), 6)) AS x FROM (SELECT vec_id AS row_id, 1 + vec_id % 5 AS level, embedding FROM embeddings), range(2) t(l)").replace("WITH  ", "", 1))
def f01_user_source(spark, d):
    """Vectors of two layers from a user's function over batches of rows."""

    def user(layer, frame):
        return np.stack(frame["embedding"].to_numpy())[:, 4 * layer : 4 * layer + 4].astype(float) * (layer + 2)

    rows = fx.emb(spark, d).select("row_id", F.col("level").cast("long").alias("level"), "embedding")
    return U.states_from(rows, [0, 1], user, fields=("level",), width=4).select("row_id", F.col("layer").cast("long").alias("layer"), "level", A.rounded(F.col("x")).alias("x"))


@query(sql("SELECT state, count(*) AS n, round(avg(label), 6) AS accuracy FROM rt GROUP BY state", "rt"))
def f02_user_analysis(spark, d):
    """A user's table of prepared routes and labels, stored as a trial's and read back."""

    def user(df):
        return {"by_state": df.groupBy("state").agg(F.count("*").alias("n"), r6(F.avg("label"), "accuracy"))}

    return U.analyse(fx.rt(spark, d), user, f"{shared_dir(spark)}/analyses/{uuid.uuid4().hex}", "one")["by_state"]


@query(sql("SELECT layer, arg_min(k, (abs(silhouette - 0.05), k)) AS k FROM scan GROUP BY layer", "scan"))
def f03_user_selector(spark, d):
    """The K whose silhouette is nearest to a twentieth."""
    return U.select_k(fx.scan(spark, d), lambda f: f["k"][(f["silhouette"] - 0.05).abs().idxmin()])


@query(sql("SELECT layer, count(*) AS n, round(sum(x[1]), 6) AS first FROM states WHERE layer IN (0, 7) GROUP BY layer", "states"))
def s05_arrays(spark, d):
    """Layer vectors through an interchange data set: first and last layer."""
    path = f"{shared_dir(spark)}/arrays/{uuid.uuid4().hex}"
    S.export_arrays(fx.states(spark, d), path, ("embeddings", "1"))
    got, _ = S.open_arrays(spark, path, [0, -1], ("embeddings", "1"))
    return got.groupBy("layer").agg(F.count("*").alias("n"), r6(F.sum(F.col("x")[0]), "first"))


@query(sql("SELECT 'a' AS trial_id, layer, count(*) AS n, NULL::DOUBLE AS accuracy FROM rt GROUP BY layer UNION ALL SELECT 'b', layer, count(*), round(avg(label), 6) FROM rt GROUP BY layer", "rt"))
def s14_sink(spark, d):
    """Tables of two trials with differing columns through the sink."""
    path, rt = f"{shared_dir(spark)}/trials/{uuid.uuid4().hex}", fx.rt(spark, d)
    S.write_trial({"layers": rt.groupBy("layer").agg(F.count("*").alias("n"))}, path, "a")
    S.write_trial({"layers": rt.groupBy("layer").agg(F.count("*").alias("n"), r6(F.avg("label"), "accuracy"))}, path, "b")
    return spark.read.option("mergeSchema", True).parquet(f"{path}/layers").select("trial_id", "layer", "n", "accuracy")


@query()
def s17_inventory(spark, d):
    """All files of the given tables with size and digest."""
    return S.inventory(spark, d)


def _streamed(spark, d, make, mode="append"):
    """Runs a stream over the events table, beside each response's number of units, to its end,
    into the shared folder."""
    schema = fx.table(spark, d, "events").schema
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    units = fx.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n_tokens"))
    src = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    q = make(src.join(units, "user_id")).writeStream.outputMode(mode).format("parquet").option("checkpointLocation", base + "/log").option("path", base + "/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(base + "/out")


@query(sql("SELECT sample AS user_id, token_end::BIGINT AS token_end, round(avg(score) OVER (PARTITION BY sample ORDER BY token_end) + 1e-9, 6) AS mean FROM evt", "evt"))
def w06_stream_prefix_mean(spark, d):
    return _streamed(spark, d, stream.prefix_means).select("user_id", "token_end", F.round(F.col("mean") + 1e-9, 6).alias("mean"))


@query(sql(far_sql(True) + " SELECT sample AS user_id, min(token_end)::BIGINT AS token_end, arg_min(score, token_end) AS score FROM evt, th WHERE score > threshold GROUP BY sample", "evt"))
def w07_stream_alarms(spark, d):
    """Alarms over the threshold calibrated on the stored responses."""
    threshold = monitor.far_threshold(fx.evt(spark, d), 0.1).first()[0]  # one number
    return _streamed(spark, d, lambda s: stream.alarms(s, threshold))


@query(sql("SELECT event_type AS a, b, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY sample ORDER BY token_end) AS b FROM evt) WHERE b IS NOT NULL GROUP BY ALL", "evt"))
def w08_stream_transitions(spark, d):
    return _streamed(spark, d, stream.transition_pairs).groupBy("a", "b").agg(F.count("*").alias("n"))
