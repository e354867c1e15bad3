"""Errors of assignments that cannot be done safely; all are ValueErrors."""


class CrsMismatchError(ValueError):
    """Coordinate systems differ, or a geometry can't be expressed in another one."""


class PartialCoverageError(ValueError):
    """A hazard reaches outside the population grid."""


class MissingPopulationDataError(ValueError):
    """The population grid has no values where a hazard lies."""


class PopulationDataError(ValueError):
    """A catalog dataset can't be found, read or trusted."""
