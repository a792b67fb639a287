"""Decision analytics on DataFrames: calibration, selective-risk cuts, paired tests, ranking, series and data quality."""
