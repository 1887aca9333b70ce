"""Line-set analytics on Spark DataFrames: ordered sets of byte lines."""
