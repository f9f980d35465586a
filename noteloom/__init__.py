"""noteloom: corpus-scale evidence retrieval and content organisation on Spark."""
