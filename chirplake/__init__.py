"""chirplake: catalogue analytics for transient searches on Spark DataFrames."""
