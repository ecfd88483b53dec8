"""docframe: PySpark jobs for exploring and reshaping JSON documents and tables at scale."""
