"""Spark jobs for irregularly sampled time series: spectra, divergences, cleaning, and the tables around them."""
