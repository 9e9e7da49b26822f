"""Listing analytics on Spark: DataFrame operators over dated, located, multi-labelled listings."""
