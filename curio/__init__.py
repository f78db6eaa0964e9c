"""Curio: Spark jobs that turn shared text and landed pages into an organised link collection."""
