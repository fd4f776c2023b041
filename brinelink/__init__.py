"""Pairing, checking and correcting geolocated ocean observations with Spark DataFrames.

Every public function takes DataFrames (plus parameters) and returns a DataFrame, so
the steps compose with any other Spark code and Catalyst sees the whole plan.
"""
