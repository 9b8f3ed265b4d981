"""docquarry: document analytics and retrieval as lazy PySpark DataFrame operators."""
