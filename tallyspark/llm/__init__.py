"""Operators of a training-data pipeline over ``documents`` and ``pages``.

One module per operator; ``queries`` registers them.  Functions that run in
Spark's Python workers are shipped by value, so executors need no copy of the
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
