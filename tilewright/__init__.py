"""Vector geodata and text preparation on PySpark."""
