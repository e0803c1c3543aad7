"""Seafloor-layer analytics expressed as Spark DataFrame transformations."""
