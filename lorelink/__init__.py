"""lorelink: entity linking and the analytics around it, as Spark plans."""
