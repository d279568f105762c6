"""Synthetic fleet data of any size, made on the executors."""
