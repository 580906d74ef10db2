"""Training-data operators: thirteen corpus-scale jobs and their queries.

Nothing else in the library imports this subpackage.  Functions that run in
Python workers are shipped by value, so an executor needs only the public
libraries (numpy, pyarrow, tiktoken, tokenizers), not this package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
