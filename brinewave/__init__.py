"""brinewave: Spark-native analytics for collections of long recordings."""
