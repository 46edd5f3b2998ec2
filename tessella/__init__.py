"""Code-structure analytics and training-data operators as PySpark DataFrame programs."""
