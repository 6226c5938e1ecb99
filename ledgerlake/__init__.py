"""Sales lakehouse and demand forecasting as ordinary Spark DataFrame functions."""
