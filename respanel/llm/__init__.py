"""Training-data operators on documents, pages and conversations.

Nothing else in the library imports this subpackage; ``queries.py`` lists its
driver queries and ``corpus_pipeline.py`` at the repository top chains five
of its operators.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to executors by value, so these need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
