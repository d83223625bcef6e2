"""Readers and writers: arrivals, archives, XML, CSV, GPX, stored tables."""
