"""Reading evidence tables and turning text, XML and numeric records into them."""
