"""Operators for preparing language-model training data.

Nothing else in the library imports this package. ``levelwise.llm.queries`` registers one
query per operator; the operators themselves keep general interfaces.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
