"""A PySpark-native engine for sparse contact maps: bins that tile a genome, and pixels that count contacts of two bins."""
