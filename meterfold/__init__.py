"""Consent-registry and metering analytics as Spark DataFrame operators."""
