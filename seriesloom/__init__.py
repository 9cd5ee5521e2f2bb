"""Panel time-series analytics expressed as Spark DataFrame plans."""

from seriesloom.spec import Frequency, PanelSpec, make_spec

__all__ = ["Frequency", "PanelSpec", "make_spec"]
