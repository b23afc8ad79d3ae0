"""XML Schema as a schema language for DataFrames."""

from .plans.model import Builder, DocumentError, Facets, Model, Report, load, load_bytes, load_files, load_string
from .plans.schema import Diagnostic, SchemaError, SchemaSet

__all__ = ["Builder", "Diagnostic", "DocumentError", "Facets", "Model", "Report", "SchemaError", "SchemaSet", "load", "load_bytes", "load_files", "load_string"]
