"""Evidence-retrieval and training-data analytics as Spark DataFrame jobs."""

import os
import sys
from pathlib import Path

from pyspark import cloudpickle

# Python workers import the package by name where it is on their path; elsewhere its functions travel by value.
if str(Path(__file__).resolve().parent.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
