"""A Spark-native definition engine: declared numbers lowered to DataFrame plans."""
