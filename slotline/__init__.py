"""slotline: Spark-native operators for keyed, regularly sampled time series."""
