"""fillgauge: analytics on Spark for things with a level and a capacity over time."""
