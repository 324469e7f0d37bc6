"""``DataFrame -> DataFrame`` building blocks, for use through ``df.transform``."""
