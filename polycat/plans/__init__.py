"""Weight rows derived from the driver's tables, so that both engines can make them."""
