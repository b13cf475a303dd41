"""Find waste in multi-cloud billing data with Spark.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing runs until the caller asks for a result, except where a
docstring says otherwise (model fitting, writing).
"""

__version__ = "0.1.0"
