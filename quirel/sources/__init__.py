"""quirel.sources"""
