"""Table-markup, conversation, reward and metric operators as Spark DataFrame plans."""
