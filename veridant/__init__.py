"""veridant: evidence and time-series analytics expressed as Spark DataFrame plans.

Every operator is a function of DataFrames that returns a DataFrame; actions happen
only where an operator needs a size before it can choose a plan, and those places say so.
"""

__version__ = "0.1.0"
