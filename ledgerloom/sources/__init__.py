"""Reading raw filings data and writing results."""
