"""billow: a Spark-first engine for bill-of-materials data.

Tables of repositories, dependency artifacts and releases are kept as versioned rows and read through DataFrame
functions. Every operator takes DataFrames and returns a DataFrame; none of them starts a job unless its docstring
says so.
"""

__version__ = "0.1.0"
