"""riverframe: hydrologic and hydraulic analytics expressed as Spark DataFrame plans."""
