"""Training-data operators: quality, dedup, decontamination, safety, packing, chat.

Nothing else in the library imports this package.  Its functions reach Python
workers by value, so executors need no installed copy of the library.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
