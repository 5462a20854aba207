"""granary: a PySpark engine for building, filtering, mixing and scoring text corpora."""
