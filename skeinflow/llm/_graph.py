"""Connected components of a link table."""

from skeinflow.operators.components import components, merged

__all__ = ["components", "merged"]
