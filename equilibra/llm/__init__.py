"""Operators for building training corpora at scale.

Thirteen operators, one module each; ``queries.py`` registers one query per operator
over the given tables.  Nothing else in the library imports this package.
Python that runs inside tasks is shipped by value, so executors need the
third-party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
