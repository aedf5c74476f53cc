"""Document corpus engine on PySpark: scan, admit, chunk, filter, import and evaluate text corpora.

Functions that run inside Python workers are pickled by value, so a cluster needs no copy of this
package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
