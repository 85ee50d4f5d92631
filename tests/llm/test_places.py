"""Sharding and licence scans."""

import hashlib
import itertools
import math
import random
import re
import textwrap

from pyspark.sql import functions as F

from layerroutes.llm.licenses import TEXTS, scan, templates, words
from layerroutes.llm.sharding import BITS, shards

SCHEMA = "doc_id long, text string, path string, h long, dir string, license string, depth int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, p, 1, "d", None, None) for i, t, p in rows], SCHEMA)


def test_shards_match_brute_force(spark):
    r = random.Random(3)
    rows = [(i, None if i % 50 == 0 else "é" * r.randint(0, 60), None) for i in range(700)]
    limit = 300
    h = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) for i, *_ in rows}
    size = {i: len((t or "").encode()) for i, t, _ in rows}
    got = {x.doc_id: x for x in shards(frame(spark, rows).repartition(4), limit).collect()}
    assert len(got) == len(rows)
    for i in h:
        for depth in range(BITS + 1):
            at = h[i] >> (BITS - depth)
            total = sum(size[k] for k in h if h[k] >> (BITS - depth) == at)
            if total <= limit or depth == BITS:
                break
        assert (got[i].depth, got[i].shard, got[i].part, got[i].shard_bytes) == (depth, at, 0, total)


def test_shards_edges(spark):
    assert shards(frame(spark, []), 10).count() == 0
    rows = [(1, "a" * 40, None)] * 30 + [(1, "b" * 500, None), (None, "c", None), (None, None, None), (2, "z" * 900, None)]
    got = shards(frame(spark, rows).repartition(3), 200).collect()
    assert len(got) == len(rows)
    sizes = {}
    for x in got:
        sizes.setdefault((x.depth, x.shard, x.part), []).append(x.n_bytes)
    assert all(sum(v) <= 200 or len(v) == 1 for v in sizes.values())


def brute(rows, threshold=0.8, share=0.5):
    """Every unit against every template, with no filter."""
    given = [(n, k, words(x)) for n, k, x in templates()]
    n, vocab = len(rows), {w for *_, x in given for w in x}
    split = lambda t: re.findall(r"[a-z0-9]+(?:\.[a-z0-9]+)*", t.lower())
    df = {w: sum(w in split(t or "") for _, t, _ in rows) for w in vocab}
    vec = lambda ws: {w: ws.count(w) * (math.log((1 + n) / (1 + df.get(w, 0))) + 1) for w in set(ws)}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    sides = [(name, title, vec(x)) for name, title, x in given]
    notice = re.compile("licen[cs]ed under|released under|distributed under the|spdx.license.identifier|permission is hereby granted|redistribution and use", re.IGNORECASE)
    claim = re.compile(notice.pattern + r"|under the terms of|all rights reserved|permission (is|to use)\b.{0,40}\b(granted|copy)|distributed under|licen[cs]ed to you", re.IGNORECASE)
    comment = re.compile(r"\s*(#|//|/\*|\*|;|--|<!--|%|\"\"\"|'''|rem\b|dnl\b)", re.IGNORECASE)

    def numbered(ws):
        return {re.sub(r"(\.0)+$", "", w.removeprefix("v")) for w in ws if re.fullmatch(r"v?\d\d?(\.\d+)*", w)}

    def match(ws):
        v, said = vec(ws), numbered(ws)
        sims = [(-round(sum(v.get(k, 0) * u[k] for k in u) / norm(u) / norm(v), 9), name, not title) for name, title, u in sides if not said or numbered(u) <= said] if ws else []
        b = min(sims, default=(0, "", True))
        return (-b[0], b[1], not b[2]) if -b[0] >= threshold else None

    def own(text):
        lines = (text or "").split("\n")
        ws = [split(x) for x in lines]
        flat = lambda a, b: [w for x in ws[a:b] for w in x]
        units, code = [(0, 0, len(lines), flat(0, len(lines)))], False
        full = [k for k, x in enumerate(ws) if x]
        if full and comment.match(lines[full[0]]):
            end = next((k for k in range(full[0], len(lines)) if not comment.match(lines[k])), len(lines))
            units.append((1, full[0], end, flat(full[0], end)))
            code = len(units[1][3]) < len(units[0][3])
        paragraphs = [list(g) for k, g in itertools.groupby(range(len(lines)), lambda k: bool(ws[k])) if k]
        units += [(2, p[0], p[-1] + 1, flat(p[0], p[-1] + 1)) for p in paragraphs]
        for p in paragraphs:
            for k, g in itertools.groupby(p, lambda k: 2 * sum(w in vocab for w in ws[k]) >= len(ws[k])):
                g = list(g)
                if k and 1 < len(g) < len(p):
                    units.append((3, g[0], g[-1] + 1, flat(g[0], g[-1] + 1)))
            units += [(4, k, k + 1, ws[k]) for k in p if len(p) > 1]
            units += [(5, k, k + 1, split(x)) for k in p if notice.search(lines[k]) for x in re.split(r"(?<=[.!?])\s+", lines[k])]
        hits = [(level, a, b, u, h) for level, a, b, u in units if (h := match(u))]
        if not hits:
            return None, 0.0, False, bool(claim.search(text or ""))
        best = min((level, -h[0], a, h[1]) for level, a, _, _, h in hits)
        title = any(level == 2 and a == paragraphs[0][0] and h[2] for level, a, _, _, h in hits)
        covered = {k for level, a, b, _, _ in hits if level < 5 for k in range(a, b)}
        whole = len(units[0][3])
        return best[3], -best[1], not code and (best[0] == 0 or title or sum(len(ws[k]) for k in covered) >= share * whole), False

    found, files, out = [own(t) for _, t, _ in rows], {}, []
    for (_, _, p), (name, sim, is_file, _) in zip(rows, found, strict=True):
        if is_file and p is not None:
            d = p.rpartition("/")[0]
            files[d] = min(files.get(d, (9, "", "")), (-sim, name, p))
    for (i, _, p), (name, sim, is_file, unknown) in zip(rows, found, strict=True):
        if name or unknown:
            out.append((i, p, name, "unknown" if unknown else "file" if is_file else "header", sim, None))
            continue
        d = p.rpartition("/")[0] if p is not None else None
        while d is not None and d not in files and d:
            d = d.rpartition("/")[0]
        heir = files.get(d) if d is not None else None
        out.append((i, p, heir and heir[1], "inherited" if heir else "none", 0.0, d if heir else None))
    return sorted(out, key=repr)


def wrapped(text, lead=""):
    return "\n".join(lead + x for p in text.split("\n") for x in (textwrap.wrap(p, 72) or [""]))


def test_scan_matches_brute_force(spark):
    r = random.Random(8)
    notes = [x for _, _, x in r.sample(templates(), 25)] + [TEXTS["MIT"][0], TEXTS["Apache-2.0"][1], "Licensed under the Foo Terms 9."]
    rows = [(0, notes[0], "LICENSE"), (1, "plain words\nmore", "a/b/x"), (2, None, "a/y"), (3, "", None), (4, notes[3], None), (5, notes[0], "a/b/c/LICENSE"), (6, notes[3], "a/b/c/NOTICE")]
    for i in range(7, 150):
        p = "/".join(r.choice("abc") for _ in range(r.randint(0, 4)))
        body = " ".join(r.choice(["some", "the", "license", "words", "version", "\n", "under"]) for _ in range(r.randint(0, 30)))
        x = r.choice(notes)
        t = r.choice([body, body + "\n" + x, x, x + "\nCopyright 2020 someone", x.upper(), wrapped(x, "# ") + "\n" + body, wrapped(x) + "\n\n" + body, "Copyright 2020 X. " + x, body + "\n" + wrapped(x) + "\n" + body])
        rows.append((i, t, f"{p}/f{i}" if p else f"f{i}"))
    rows += [rows[8], rows[9], (200, "x " * 20_000 + "\n" + notes[1], "z/long")]
    got = sorted((tuple(x) for x in scan(frame(spark, rows).repartition(3), F.col("path")).collect()), key=repr)
    want = brute(rows)
    assert [(*x[:4], round(x[4], 6), x[5]) for x in got] == [(*x[:4], round(x[4], 6), x[5]) for x in want]
    assert {x[3] for x in got} == {"file", "header", "inherited", "unknown", "none"}
    assert scan(frame(spark, []), F.col("path")).count() == 0


def test_scan_knows_real_licences(spark):
    mit = "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + TEXTS["MIT"][1].removeprefix("MIT License ").replace("conditions: ", "conditions:\n\n")
    gpl = "Foo is a tool. Copyright (C) 2019 A B\n" + TEXTS["GPL-3.0"][1].replace("This program", "Foo")
    rows = [
        (1, wrapped(mit), "a/LICENSE"), (2, "x = 1\n" * 9, "a/src/m.py"),
        (3, wrapped("Copyright 2020 X Corp.\n" + TEXTS["Apache-2.0"][1], "# ") + "\n\nimport os\n", "a/src/h.py"),
        (4, "/*\n" + wrapped(gpl, " * ") + "\n */\nint main() { return 0; }\n" * 5, "d/h.c"),
        (5, "Copyright (c) 2011, Y\nAll rights reserved.\n\n" + wrapped(TEXTS["BSD-3-Clause"][1]), "d/LICENSE"), (6, "y = 2", "d/e/f/y.py"),
        (7, "some code\nLicensed under the House Terms 3.\nmore", "d/odd.txt"), (8, "// SPDX-License-Identifier: AGPL-3.0-only\nint a;", "d/s.c"),
    ]
    got = {x.doc_id: (x.license, x.origin) for x in scan(frame(spark, rows), F.col("path")).collect()}
    assert got == {
        1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "header"), 4: ("GPL-3.0", "header"), 5: ("BSD-3-Clause", "file"),
        6: ("BSD-3-Clause", "inherited"), 7: (None, "unknown"), 8: ("AGPL-3.0", "header"),
    }


def test_versions_expressions_and_unknown_notices(spark):
    texts = {
        "b/LICENSE": TEXTS["MIT"][1],
        "a/mpl": "Distributed under the Mozilla Public License 1.1.", "a/mpl2": "Distributed under the Mozilla Public License 2.0.",
        "a/two": "// SPDX-License-Identifier: MIT OR Apache-2.0\nint a;", "a/nested": "# SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0 AND MIT) OR BSD-3-Clause",
        "a/odd": "SPDX-License-Identifier: MIT AND Foo-1.0", "a/one": "SPDX-License-Identifier: MIT",
        "a/gfdl": "Permission is granted to copy, distribute and/or modify this document.", "a/terms": "You may use it under the terms of our contract.",
        "a/mine": "Copyright 2020 X. All rights reserved.", "b/plain": "no notice at all", "a/v3": "Licensed under the GPL v3.", "a/apache1": "Licensed under the Apache License, Version 1.1.",
    }
    got = {x.path: (x.license, x.origin) for x in scan(frame(spark, [(i, t, p) for i, (p, t) in enumerate(texts.items())]), F.col("path")).collect()}
    assert got.pop("a/mpl2")[0] == "MPL-2.0" and got.pop("a/one")[0] == "MIT" and got.pop("a/v3")[0] == "GPL-3.0"
    assert got == {
        "b/LICENSE": ("MIT", "file"), "b/plain": ("MIT", "inherited"),
        "a/two": ("MIT OR Apache-2.0", "header"), "a/nested": ("(GPL-2.0 AND MIT) OR BSD-3-Clause", "header"),
        **dict.fromkeys(["a/mpl", "a/odd", "a/gfdl", "a/terms", "a/mine", "a/apache1"], (None, "unknown")),
    }
