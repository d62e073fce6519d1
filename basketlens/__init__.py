"""basketlens: e-commerce behaviour analytics as PySpark DataFrame operators."""
