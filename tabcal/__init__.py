"""tabcal: grouped tabular modelling and calibration as Spark DataFrame operators."""
