"""corvelo: a PySpark engine for auditable research-evidence pipelines.

Every operator takes DataFrames and returns a DataFrame; nothing is collected to the driver unless
a docstring says so and names the bound.
"""

__version__ = "0.1.0"
