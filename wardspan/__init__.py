"""Behaviour analytics on Spark: normalised events, features, detectors, alerts and cases."""
