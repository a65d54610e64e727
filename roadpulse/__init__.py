"""Vehicle-trace analytics expressed as Spark DataFrame jobs.

GPS points become matched positions, matched positions become travel-time and
turning-time observations, and observations become five-minute road speeds.
Every operator is a function from DataFrames and parameters to a DataFrame.
"""
