"""Keyed-event analytics expressed as Spark DataFrame plans and stateful streams."""
