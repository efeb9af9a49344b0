"""Person-period propensity analytics on Spark DataFrames."""

from cohortica.spec import PanelSpec

__all__ = ["PanelSpec"]
