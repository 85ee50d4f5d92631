"""All queries of the library."""

from layerroutes.plans import channels, contrasts, evaluation, fitted, models, readouts, routes, studies, tables, trajectories, vectors
from layerroutes.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "channels", "contrasts", "evaluation", "fitted", "models", "readouts", "routes", "studies", "tables", "trajectories", "vectors"]
