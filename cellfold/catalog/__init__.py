"""Published population grids: what there is, and local copies of it with receipts."""

from cellfold.catalog.api import download, info, register, resolve
from cellfold.catalog.api import list_sources as list

__all__ = ["download", "info", "list", "register", "resolve"]
