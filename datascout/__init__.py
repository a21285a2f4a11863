"""PySpark-native catalog, profiling and search jobs for collections of open datasets."""
