"""Analytics over archives of AI conversations, as PySpark DataFrame operators."""
