"""Training-data operators: fingerprints, sanitising, mixing, packing, quality, scoring, dedup.

Nothing outside this subpackage imports it.  Every module is one operator with a general
DataFrame-in / DataFrame-out function; ``queries`` derives the registered result digests.
"""

import sys

from pyspark import cloudpickle

# Executors get the functions of this subpackage by value, so no worker needs it on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
