"""Language-model analytics over Spark tables: ranking, feedback models, sessions, topics."""
