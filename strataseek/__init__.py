"""strataseek: file and document search analytics on the Spark DataFrame API."""

__version__ = "0.1.0"
