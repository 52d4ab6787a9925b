"""topicloom: a Spark-native topic-modelling engine over plain DataFrames."""
