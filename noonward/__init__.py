"""Day-ahead forecasting analytics for hourly plant series, built on Spark DataFrames."""
