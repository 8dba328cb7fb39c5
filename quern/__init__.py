"""quern: conversation-log analytics and training-data preparation on PySpark."""
