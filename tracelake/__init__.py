"""Packet and flow analytics on Spark DataFrames."""
