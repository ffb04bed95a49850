"""Complex-event processing over device events and locations, on PySpark DataFrames."""
