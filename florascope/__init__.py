"""PySpark-native analytics for species-occurrence data and distribution modelling."""
