"""Gridded sea-surface-temperature and bleaching analytics as Spark DataFrame operators."""
