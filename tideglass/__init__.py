"""tideglass."""
