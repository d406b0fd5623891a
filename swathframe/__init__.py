"""swathframe: Earth-observation analytics on Spark DataFrames.

Two tables carry everything: ``scenes`` (one row per satellite acquisition) and
``pixels`` (one row per tile, row and column; one DOUBLE column per band).
Every operator takes and returns DataFrames or Columns.
"""

__version__ = "0.1.0"
