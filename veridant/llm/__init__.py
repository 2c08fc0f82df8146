"""Operators for texts that train language models; nothing outside this folder imports it."""
