"""Log ingest and normalisation as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

from logsluice.session import configure
from logsluice.spec import DEFAULT_FORMAT, Attribute, Identity, LineKey, SinkSpec, SourceSpec

__all__ = ["DEFAULT_FORMAT", "Attribute", "Identity", "LineKey", "SinkSpec", "SourceSpec", "configure"]

# Functions sent to Python workers carry their code along, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
