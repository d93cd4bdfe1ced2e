"""threadloom.sources"""
