"""Compositions of operators: one lazy plan per job."""
