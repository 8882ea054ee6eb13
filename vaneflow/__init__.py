"""Forecast-versus-market analytics expressed as Spark DataFrame plans."""
