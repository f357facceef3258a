"""A PySpark-native engine for explanatory statistics and econometrics."""
