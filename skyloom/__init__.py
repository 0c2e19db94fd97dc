"""skyloom: sky-image and catalogue analytics as lazy PySpark DataFrames."""
