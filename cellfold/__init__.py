"""Gridded-count assignment on Spark: how many people a hazard's cells stand for."""

#: Public names and the modules they are loaded from when first used, so that workers
#: which need one module don't load all.
_WHERE = {
    "assign_population": "cellfold.assign",
    "CrsMismatchError": "cellfold.errors",
    "MissingPopulationDataError": "cellfold.errors",
    "PartialCoverageError": "cellfold.errors",
    "PopulationDataError": "cellfold.errors",
    "RasterAssignment": "cellfold.operators.regrid",
    "Assignment": "cellfold.operators.zonal",
    "GridSpec": "cellfold.sources.grid",
    "Raster": "cellfold.sources.grid",
    "VectorLayer": "cellfold.sources.layer",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module 'cellfold' has no attribute {name!r}")
    from importlib import import_module

    return getattr(import_module(_WHERE[name]), name)
