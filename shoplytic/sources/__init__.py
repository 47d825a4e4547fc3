"""Reading the shop's tables, publishing feature views, appending results."""
