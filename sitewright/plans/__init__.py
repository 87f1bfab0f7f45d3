"""The commands as plans over DataFrames."""
