"""Readers, writers and test inputs."""
