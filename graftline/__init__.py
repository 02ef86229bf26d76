"""graftline: insertion analytics and relational genomics operators on Spark DataFrames."""

__version__ = "0.1.0"
