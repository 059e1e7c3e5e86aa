"""Latent-mixture clustering of tables of vectors, written as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from mixframe.config import FeatureSpec, TableConfig
from mixframe.model import Mixture

# Functions that run in tasks travel with their code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["FeatureSpec", "Mixture", "TableConfig"]
